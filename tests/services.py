"""Three small services to index, written for these tests."""

SHOP = {
    "app/__init__.py": "",
    "app/main.py": '''from fastapi import FastAPI
from app.routes import router

app = FastAPI()
app.include_router(router, prefix="/api")
''',
    "app/routes.py": '''from fastapi import APIRouter
from app.service import place

router = APIRouter(prefix="/orders")


@router.post("/new")
async def create_order(body):
    """Takes an order."""
    return place(body)


@router.get("")
async def list_orders():
    return []
''',
    "app/service.py": '''from app.bus import outbox

TOPIC = "OrderPlaced"


def place(body):
    check(body)
    outbox.add(event_type=TOPIC, payload=body)


def check(body):
    return bool(body)


def check(body):
    return body is not None
''',
    "app/bus.py": '''class Outbox:
    def add(self, event_type, payload):
        return event_type


outbox = Outbox()
''',
    "broken.py": "def (:\n",
    ".venv/lib.py": "x = 1\n",
    "generated/skip.py": "y = 1\n",
    ".gitignore": "generated/\n",
}
WORKER = {
    "worker/main.py": '''from worker.handlers import on_order
from lib import Dispatcher

Dispatcher(handlers={"OrderPlaced": on_order, "Nothing": missing})
''',
    "worker/handlers.py": '''from worker.flow import OrderFlow
from worker.docs_client import DocsClient


async def on_order(event):
    await client.start_workflow(OrderFlow.run, event)
''',
    "worker/flow.py": '''from temporalio import activity, workflow
from worker.docs_client import fetch


@activity.defn
async def load(doc_id):
    return fetch(doc_id)


@workflow.defn
class OrderFlow:
    @workflow.run
    async def run(self, event):
        await workflow.execute_activity(load, event)

    @workflow.signal(name="approved")
    def approve(self):
        self.done = True
''',
    "worker/docs_client.py": '''class DocsClient:
    def __init__(self, session):
        self.session = session

    async def get_doc(self, doc_id):
        return await self.session.get(f"{self.host}/docs/{doc_id}")


client = DocsClient(None)


def fetch(doc_id):
    return client.get_doc(doc_id)
''',
}
DOCS = {
    "api.py": '''from fastapi import FastAPI

app = FastAPI()


@app.get("/docs/{doc_uid}")
def get_document(doc_uid):
    return handle.signal("approved")
''',
    "deps.py": '''from fastapi import APIRouter, Depends
from settings import Kind

router = APIRouter()


def get_db():
    return None


@router.get("/health")
def health(db=Depends(get_db)):
    return events.publish(Kind(db), 1)
''',
    "settings.py": '''from enum import Enum
from pydantic_settings import BaseSettings, SettingsConfigDict


class Settings(BaseSettings):
    model_config = SettingsConfigDict(env_prefix="DOCS_")
    topic: str = "docs"
    url: str = Field("u", alias="DOC_URL")


class Kind(str, Enum):
    A = "a"
    B = "b"
''',
}


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)
